"""Registered queries of the document-routing operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import config as C
from quillspark.functions import extraction as X
from quillspark.functions import replies as L
from quillspark.functions import routing as R
from quillspark.functions import text as T
from quillspark.operators import backends, collisions, evaluation, feedback, folders, history, lookups, markers, vectors
from quillspark.plans import plan as P
from quillspark.plans.plan import plan
from quillspark.plans.statements import STATEMENT_SQL, statements
from quillspark.scratch import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- SQL pieces

_NUM, _SIGN = r"([\d,]+(?:\.\d{1,2})?)", r"(?:\$|S/\.?|€|£)?\s*"


def _clean(expr: str) -> str:
    return f"replace({expr}, ',', '')"


def _strict(label: str) -> str:
    return _clean(rf"regexp_extract(text, '(?i){label}[:\s]*{_SIGN}{_NUM}', 1)")


def _loose(label: str) -> str:
    return _clean(rf"regexp_extract(short, '(?is){label}.{{0,150}}?[=:]\s*{_SIGN}{_NUM}', 1)")


def _first_valid(parts: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN try_cast({p} AS DOUBLE) >= 1 THEN {p} END" for p in parts) + ")"


def _zero(parts: list[str]) -> str:
    return "(" + " OR ".join(f"coalesce(try_cast({p} AS DOUBLE) = 0, false)" for p in parts) + ")"


def _collapsed(expr: str) -> str:
    for c in "-=_.":
        expr = rf"regexp_replace({expr}, '\{c}{{3,}}', '{c}', 'g')"
    return rf"regexp_replace({expr}, '\s+', ' ', 'g')"


_S, _LO = [_strict(x) for x in C.AMOUNT_LABELS], [_loose(x) for x in C.AMOUNT_LABELS]
_MONTH = lambda e: "CASE lower(" + e + ") " + " ".join(f"WHEN '{k}' THEN '{v:02d}'" for k, v in C.MONTHS.items()) + " END"
_PER = r"(?i)(?:billing period|service period|statement period)[:\s]+([A-Za-z]{3,9})\s+(\d{1,2})\s*[-–—to]+\s*[A-Za-z]{3,9}\s+\d{1,2}[,\s]+(\d{4})"
_NAM = r"(?i)\b([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})\b"
_NUMERIC = r"\b(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})\b"


def _ex(t: str, p: str, g: int = 1) -> str:
    return f"regexp_extract({t}, '{p}', {g})"


def _named(p: str) -> str:
    m = _MONTH(_ex("b", p, 1))
    return f"CASE WHEN {m} IS NOT NULL THEN {_ex('b', p, 3)} || '-' || {m} || '-' || lpad({_ex('b', p, 2)}, 2, '0') END"


def _fit(m: str, d: str) -> str:
    return f"try_cast({m} AS INT) BETWEEN 1 AND 12 AND try_cast({d} AS INT) BETWEEN 1 AND 31"


_STEM = r"regexp_replace(filename, '\.[^.]+$', '')"
#: Dates at the start of a file name, as the extraction reads them.
_F1 = r"^(\d{4})(\d{2})(\d{2})(?:[_\-]|$)"
_F2 = r"^(\d{4})[\-._](\d{1,2})[\-._](\d{1,2})(?:\D|$)"
_F3 = r"^(\d{4})[\-._](\d{1,2})(?:\D|$)"
_FILE_DATE = f"""CASE
  WHEN {_fit(_ex(_STEM, _F1, 2), _ex(_STEM, _F1, 3))} THEN {_ex(_STEM, _F1, 1)} || '-' || {_ex(_STEM, _F1, 2)} || '-' || {_ex(_STEM, _F1, 3)}
  WHEN {_fit(_ex(_STEM, _F2, 2), _ex(_STEM, _F2, 3))} THEN {_ex(_STEM, _F2, 1)} || '-' || lpad({_ex(_STEM, _F2, 2)}, 2, '0') || '-' || lpad({_ex(_STEM, _F2, 3)}, 2, '0')
  WHEN try_cast({_ex(_STEM, _F3, 2)} AS INT) BETWEEN 1 AND 12 THEN {_ex(_STEM, _F3, 1)} || '-' || lpad({_ex(_STEM, _F3, 2)}, 2, '0') || '-01' END"""
_TEXT_DATE = f"""coalesce({_named(_PER)}, {_named(_NAM)},
  CASE WHEN {_fit(_ex('b', _NUMERIC, 1), _ex('b', _NUMERIC, 2))}
    THEN {_ex('b', _NUMERIC, 3)} || '-' || lpad({_ex('b', _NUMERIC, 1)}, 2, '0') || '-' || lpad({_ex('b', _NUMERIC, 2)}, 2, '0')
    WHEN {_fit(_ex('b', _NUMERIC, 2), _ex('b', _NUMERIC, 1))}
    THEN {_ex('b', _NUMERIC, 3)} || '-' || lpad({_ex('b', _NUMERIC, 2)}, 2, '0') || '-' || lpad({_ex('b', _NUMERIC, 1)}, 2, '0') END,
  nullif({_ex('b', r'\b(\d{4}-\d{2}-\d{2})\b')}, ''),
  CASE WHEN {_ex('b', r'\b(20\d{2}|19\d{2})\b')} <> '' THEN {_ex('b', r'\b(20\d{2}|19\d{2})\b')} || '-01-01' END)"""
_YEAR_ONLY = r"coalesce(date LIKE '%-01-01' AND NOT regexp_matches(lower(text), 'january\s+1|jan\.?\s+1\b|1/1/'), false)"
_SIGNS = {"d": r"\$\s*[\d,]+", "s": r"\bS/\.?\s*[\d,]+", "e": r"€\s*[\d,]+|[\d,]+\s*€", "p": r"£\s*[\d,]+"}
_CURRENCY = "CASE WHEN n_d >= greatest(n_s, n_e, n_p) THEN '$' WHEN n_s >= greatest(n_e, n_p) THEN 'S/' WHEN n_e >= n_p THEN '€' ELSE '£' END"
_ACC = {"full": (X.ACCOUNT_FULL, 1), "ending": (X.ACCOUNT_ENDING, 2), "shown": (X.ACCOUNT_ENDING, 1), "masked": (X.ACCOUNT_MASKED, 1), "short": (X.ACCOUNT_SHORT, 1)}


def _issuer_sql() -> str:
    norm = lambda e: rf"trim(regexp_replace(translate(translate(lower({e}), '&-', ''), '.,', '  '), '\s+', ' ', 'g'))"
    place = f"{norm('left(text, 1500)')} || chr(10) || CASE WHEN length(text) > 1500 THEN {norm('right(text, 1000)')} ELSE '' END || chr(10) || {norm('filename')}"
    cases = " ".join(rf"WHEN regexp_matches(places, '\b{k}') THEN '{C.ISSUERS[k]}'" for k in C.DEFAULT.issuer_keys())
    return f"SELECT *, CASE {cases} END AS issuer FROM (SELECT *, {place} AS places FROM stmt)"


def _category_sql(source: str, text: str, categories: dict, least: int) -> str:
    cols = ", ".join("(" + " + ".join(f"CAST(contains(lower({text}), '{w}') AS INT)" for w in words) + f") AS c{i}" for i, words in enumerate(categories.values()))
    top = "greatest(" + ", ".join(f"c{i}" for i in range(len(categories))) + ")"
    cases = " ".join(f"WHEN c{i} = {top} THEN '{name}'" for i, name in enumerate(categories))
    return f"SELECT *, CASE WHEN {top} < {least} THEN 'Uncategorized' {cases} END AS category FROM (SELECT *, {cols} FROM {source})"


STMT = f"stmt AS ({STATEMENT_SQL})"
_ACC_COLUMNS = ", ".join("regexp_extract(text, '" + ("" if k == "masked" else "(?i)") + p.replace("'", "''") + f"', {g}) AS a_{k}" for k, (p, g) in _ACC.items())
META = f"""{STMT},
 m1 AS ({_issuer_sql()}),
 m2 AS (SELECT *, {_collapsed('text')} AS short,
   CASE WHEN regexp_matches(text, '(?i)date\\s+of\\s+birth') THEN regexp_replace(text, '\\d{{1,2}}[/\\-]\\d{{1,2}}[/\\-]\\d{{4}}', repeat(' ', 10), 'g') ELSE text END AS b,
   {', '.join(f"len(regexp_extract_all(text, '{p}')) AS n_{k}" for k, p in _SIGNS.items())}, {_ACC_COLUMNS} FROM m1),
 m3 AS (SELECT *, coalesce({_FILE_DATE}, {_TEXT_DATE}) AS date, {_CURRENCY} AS currency,
   {_first_valid(_S)} AS strict, {_first_valid(_LO)} AS loose, {_zero(_S + _LO)} AS zero,
   {_clean(_ex('text', r'(?:\$|S/\.?)\s*([\d,]+\.\d{2})'))} AS bare,
   coalesce(nullif({_ex('text', X.OWNER[0])}, ''), nullif({_ex('text', X.OWNER[1])}, '')) AS owner,
   CASE WHEN a_full <> '' THEN a_full WHEN a_ending <> '' THEN a_ending WHEN a_masked <> '' THEN a_masked WHEN a_short <> '' THEN a_short END AS account,
   a_full = '' AND (a_ending <> '' OR a_masked <> '' OR a_short <> '') AS account_masked,
   CASE WHEN a_full <> '' THEN length(a_full) WHEN a_ending <> '' THEN coalesce(try_cast(a_shown AS INT), 4)
     WHEN a_masked <> '' THEN length(a_masked) WHEN a_short <> '' THEN 4 ELSE 0 END AS account_digits FROM m2),
 m4 AS (SELECT *, {_YEAR_ONLY} AS date_year_only, coalesce(strict, loose) IS NULL AND zero AS amount_zero,
   CASE WHEN coalesce(strict, loose) IS NOT NULL THEN coalesce(strict, loose) WHEN NOT zero AND try_cast(bare AS DOUBLE) >= 1 THEN bare END AS amount FROM m3),
 m5 AS ({_category_sql('m4', 'text', C.CATEGORIES, 2)}),
 meta AS (SELECT *, category IN ('{C.CREDIT_CARDS}', '{C.BANK}') AND amount IS NULL AND NOT amount_zero AS contract FROM m5)"""


# ---------------------------------------------------------------- extraction


@query(f"WITH {META} SELECT o_orderkey, currency FROM meta")
def currency_vote(spark, sf_dir):
    return statements(spark, sf_dir).select("o_orderkey", X.currency(F.col("text")).alias("currency"))


@query(f"WITH {STMT} SELECT o_orderkey, filename, {_FILE_DATE} AS date FROM stmt")
def date_from_filename(spark, sf_dir):
    return statements(spark, sf_dir).select("o_orderkey", "filename", X.date_from_filename(F.col("filename")).alias("date"))


@query(f"WITH {META}, x AS (SELECT o_orderkey, text, {_TEXT_DATE} AS date FROM meta) SELECT o_orderkey, date, {_YEAR_ONLY} AS date_year_only FROM x")
def date_cascade(spark, sf_dir):
    dated = statements(spark, sf_dir).select("o_orderkey", "text", X.date_from_text(F.col("text")).alias("date"))
    return dated.select("o_orderkey", "date", X.year_only(F.col("date"), F.col("text")).alias("date_year_only"))


@query(f"WITH {META} SELECT o_orderkey, sha256(b) AS blanked FROM meta")
def dob_blanking(spark, sf_dir):
    return statements(spark, sf_dir).select("o_orderkey", F.sha2(X.without_birth_dates(F.col("text")), 256).alias("blanked"))


@query(f"WITH {META} SELECT o_orderkey, strict AS amount FROM meta")
def amount_strict(spark, sf_dir):
    return statements(spark, sf_dir).select("o_orderkey", X.first_valid(X.amount_strict(F.col("text"))).alias("amount"))


@query(f"WITH {META} SELECT o_orderkey, loose AS amount FROM meta")
def amount_loose(spark, sf_dir):
    return statements(spark, sf_dir).select("o_orderkey", X.first_valid(X.amount_loose(F.col("text"))).alias("amount"))


@query(f"WITH {META} SELECT o_orderkey, amount, amount_zero FROM meta")
def amount_with_zero_flag(spark, sf_dir):
    return statements(spark, sf_dir).select("o_orderkey", X.amount(F.col("text")).alias("a")).select("o_orderkey", "a.amount", "a.amount_zero")


@query(f"WITH {META} SELECT o_orderkey, account, account_masked, account_digits FROM meta")
def account_cascade(spark, sf_dir):
    found = statements(spark, sf_dir).select("o_orderkey", X.account(F.col("text")).alias("a"))
    return found.select("o_orderkey", F.col("a.value").alias("account"), F.col("a.masked").alias("account_masked"), F.col("a.digits").cast("long").alias("account_digits"))


@query(f"WITH {META} SELECT o_orderkey, owner FROM meta")
def owner_extract(spark, sf_dir):
    return statements(spark, sf_dir).select("o_orderkey", X.owner(F.col("text")).alias("owner"))


@query(f"WITH {META} SELECT o_orderkey, issuer FROM meta")
def issuer_match(spark, sf_dir):
    return statements(spark, sf_dir).select("o_orderkey", X.issuer(F.col("text"), F.col("filename")).alias("issuer"))


_META_COLUMNS = ["date", "date_year_only", "amount", "amount_zero", "currency", "account", "account_masked", "account_digits", "owner", "issuer"]


@query(f"WITH {META} SELECT o_orderkey, {', '.join(_META_COLUMNS)} FROM meta")
def metadata_row(spark, sf_dir):
    found = statements(spark, sf_dir).select("o_orderkey", X.metadata(F.col("text"), F.col("filename")).alias("m"))
    return found.select("o_orderkey", *[F.col(f"m.{c}").cast("long").alias(c) if c == "account_digits" else F.col(f"m.{c}") for c in _META_COLUMNS])


@query("SELECT doc_id, sha1(text) AS text_hash, least(length(text) / 5000.0::DOUBLE, 1.0) AS confidence FROM documents")
def text_hash_and_confidence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.text_hash(F.col("text")).alias("text_hash"), T.confidence(F.col("text")).alias("confidence"))


# ---------------------------------------------------------------- classification, routes, names

#: Stop words as keywords, so that languages are categories of the documents.
LANGUAGES = {
    "en": (" the ", " of ", " and "),
    "de": (" der ", " die ", " und "),
    "fr": (" les ", " que ", " de ", " la "),
    "es": (" el ", " los ", " una ", " de ", " la "),
}
LANGUAGE_CONFIG = C.RoutingConfig(categories=LANGUAGES)


@query(_category_sql("documents", "text", LANGUAGES, 2).replace("SELECT *, CASE", "SELECT doc_id, CASE", 1))
def classify_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.classify(F.col("text"), LANGUAGE_CONFIG).alias("category"))


@query(f"WITH {META} SELECT o_orderkey, category FROM meta")
def classify_statements(spark, sf_dir):
    return statements(spark, sf_dir).select("o_orderkey", R.classify(F.col("text")).alias("category"))


def _long(categories: dict) -> str:
    return ", ".join(f"({o}, '{c}', '{w}')" for o, (c, words) in enumerate(categories.items()) for w in words)


@query(
    f"WITH k(ord, category, keyword) AS (VALUES {_long(LANGUAGES)}) SELECT doc_id, category, count(*) AS score FROM documents "
    "JOIN k ON contains(lower(text), keyword) GROUP BY doc_id, category HAVING count(*) >= 2"
)
def category_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(R.category_scores(F.col("text"), LANGUAGES)).alias("s"))
    return docs.where("s.score >= 2").select("doc_id", "s.category", F.col("s.score").cast("long").alias("score"))


def _runs_sql(text: str, n: int) -> str:
    """The different runs of so many digits, every rule of the tables below ending in one."""
    runs = f"regexp_extract_all({text}, '[0-9]{{{n},}}')"
    return f"list_distinct(flatten([[r[i:i + {n - 1}] FOR i IN range(1, length(r) - {n - 2})] FOR r IN {runs}]))"


_KEYWORDS = """SELECT c_mktsegment AS category, CASE c_custkey % 3 WHEN 0 THEN 'XXXX' WHEN 1 THEN 'ending in ' ELSE '# 12-' END || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS keyword,
  c_custkey AS "order" FROM customer"""


@query(
    f"""WITH {STMT}, k AS (SELECT category, lower(keyword) AS word FROM ({_KEYWORDS})), t AS MATERIALIZED (SELECT o_orderkey, lower(text) AS low FROM stmt),
 x AS (SELECT o_orderkey, low, unnest({_runs_sql('low', 4)}) AS run FROM t)
 SELECT o_orderkey, category, count(*) AS score FROM x JOIN k ON run = right(word, 4) WHERE contains(low, word) GROUP BY o_orderkey, category"""
)
def category_scores_by_table(spark, sf_dir):
    """Scores with a keyword of every customer, from a table."""
    found = lookups.keyword_scores(statements(spark, sf_dir), _keywords(spark, sf_dir), id_col="o_orderkey")
    return found.select("o_orderkey", "category", "score")


def _keywords(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(_KEYWORDS.replace('"order"', "`order`"))


_ISSUER_KEYS = """SELECT CASE c_custkey % 4 WHEN 0 THEN 'ending-in ' WHEN 1 THEN 'XXXX' WHEN 2 THEN '# 12-' ELSE 'card ending, in ' END || lpad(CAST(c_custkey % 10000 AS STRING), 4 - CAST(c_custkey % 5 = 0 AS INT), '0') AS key,
  'Customer ' || CAST(c_custkey AS STRING) AS issuer, c_custkey AS "order" FROM customer"""
_PLACES = r"trim(regexp_replace(translate(translate(lower(%s), '&-', ''), '.,', '  '), '\s+', ' ', 'g'))"


@query(
    f"""WITH {STMT}, k AS (SELECT *, {_PLACES % 'key'} AS plain FROM ({_ISSUER_KEYS})),
 p AS MATERIALIZED (SELECT o_orderkey, {_PLACES % 'left(text, 1500)'} || chr(10) || CASE WHEN length(text) > 1500 THEN {_PLACES % 'right(text, 1000)'} ELSE '' END || chr(10) || {_PLACES % 'filename'} AS places FROM stmt),
 x AS (SELECT *, unnest({_runs_sql('places', 3)}) AS run FROM p)
 SELECT o_orderkey, arg_max(issuer, (length(key), -"order")) AS issuer FROM x JOIN k ON run = right(plain, 3)
 WHERE CASE WHEN contains(places, plain) THEN regexp_matches(places, '\\b' || plain) ELSE false END GROUP BY o_orderkey"""
)
def issuer_by_table(spark, sf_dir):
    """Issuers with a key of every customer, from a table."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    keys = spark.sql(_ISSUER_KEYS.replace('"order"', "`order`"))
    return lookups.issuers_by(statements(spark, sf_dir), keys, id_col="o_orderkey", name_col="filename")


_SEG = lambda e: f"array_to_string(list_filter(regexp_split_to_array({e}, '[/\\\\]'), lambda p: p <> '' AND p <> 'Unknown'), '\\')"
_TEMPLATE = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.ROUTE_TEMPLATES.items() if k != "default") + f" ELSE '{C.ROUTE_TEMPLATES['default']}' END"


def _filled() -> str:
    e = _TEMPLATE
    values = {
        "category": "category", "issuer": "coalesce(issuer, 'Unknown')", "owner": "coalesce(owner, 'Unknown')", "account": "coalesce(account, 'Unknown')",
        "year": "coalesce(left(date, 4), 'Unknown')", "date": "coalesce(date, '')", "amount": "coalesce(amount, '')",
    }
    for k, v in values.items():
        e = f"replace({e}, '{{{k}}}', {v})"
    return e


_CONTRACT_PATH = f"replace(replace({_TEMPLATE}, '/{{year}}', ''), '{{issuer}}', coalesce(issuer, 'Unknown'))"
_ROUTE = f"CASE WHEN category = '{C.TAXES}' AND date_year_only AND amount IS NULL THEN '{C.TAXES}\\Forms' WHEN contract THEN {_SEG(_CONTRACT_PATH)} ELSE {_SEG(_filled())} END"
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_DATE_PART = f"""CASE WHEN date IS NULL THEN NULL WHEN date_year_only THEN left(date, 4)
  WHEN category IN {_IN(C.DEFAULT.monthly_categories)} AND NOT (contract AND category IN {_IN((C.CREDIT_CARDS, C.BANK))}) THEN left(date, 4) || '.' || substr(date, 6, 2)
  ELSE replace(date, '-', '.') END"""
_KIND = "CASE WHEN contract THEN 'Contract' ELSE CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.DOC_TYPES.items()) + " END END"
_NAME = f"""regexp_replace(concat_ws(' - ', {_DATE_PART},
  coalesce(nullif(concat_ws(' ', issuer, {_KIND}), ''), left({_STEM}, 50)),
  CASE WHEN category IN {_IN(C.DEFAULT.account_in_filename_categories)} THEN
    CASE WHEN account_masked THEN '(Last' || CASE WHEN account_digits = 0 THEN 4 ELSE account_digits END || ' ' || account || ')' ELSE '(' || account || ')' END END,
  CASE WHEN category NOT IN {_IN(C.DEFAULT.no_amount_categories)} AND try_cast(amount AS DECIMAL(38,2)) > 0 THEN currency || CAST(try_cast(amount AS DECIMAL(38,2)) AS VARCHAR) END),
  '[<>:"/\\\\|?*]', '_', 'g') || regexp_extract(filename, '\\.[^.]+$')"""


def _planned(spark, sf_dir) -> DataFrame:
    docs = statements(spark, sf_dir).select("o_orderkey", F.col("filename").alias("name"), "text", F.col("o_orderkey").alias("index"))
    return plan(docs)


@query(f"WITH {META} SELECT o_orderkey, category, {_ROUTE} AS route FROM meta")
def route_path(spark, sf_dir):
    return _planned(spark, sf_dir).select("o_orderkey", "category", "route")


@query(f"WITH {META} SELECT o_orderkey, contract FROM meta")
def contract_flag(spark, sf_dir):
    p = _planned(spark, sf_dir)
    return p.select("o_orderkey", R.is_contract(F.col("category"), F.col("metadata.amount"), F.col("metadata.amount_zero")).alias("contract"))


@query(f"WITH {META} SELECT o_orderkey, {_NAME} AS new_name FROM meta")
def normalized_filename(spark, sf_dir):
    return _planned(spark, sf_dir).select("o_orderkey", "new_name")


@query(
    f"WITH {META}, p AS (SELECT o_orderkey, category, {_ROUTE} AS route, {_NAME} AS new_name FROM meta) "
    "SELECT category, route, count(*) AS n, count(DISTINCT new_name) AS names FROM p GROUP BY category, route"
)
def routing_plan_summary(spark, sf_dir):
    """The flagship: statements extracted, classified, routed and named, then summed up."""
    p = _planned(spark, sf_dir)
    return p.groupBy("category", "route").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("new_name").alias("names"))


_KNOWN = f"WITH {META}, r AS (SELECT o_orderkey, {_ROUTE} AS route FROM meta), k AS (SELECT DISTINCT route AS folder FROM r WHERE o_orderkey % 50 = 0)"
_UP = lambda e: f"regexp_replace({e}, '\\\\?[^\\\\]*$', '')"
_LAST = lambda e: f"regexp_extract({e}, '[^\\\\]*$')"


@query(
    _KNOWN
    + f""", a AS (SELECT folder FROM k UNION SELECT {_UP('folder')} FROM k WHERE length({_UP('folder')}) > 0 AND length(folder) % 2 = 0),
 u AS (SELECT {_UP('folder')} AS up, bool_or(regexp_matches({_LAST('folder')}, '^\\d{{4}}$')) AS by_year FROM a GROUP BY 1),
 s AS (SELECT r.o_orderkey, r.route, CASE WHEN o.folder IS NOT NULL THEN 'exact' WHEN b.folder IS NULL THEN 'suggest'
   WHEN regexp_matches({_LAST('r.route')}, '^\\d{{4}}$') AND contains(r.route, '\\') AND NOT coalesce(u.by_year, false) THEN 'flat' ELSE 'created' END AS status
  FROM r LEFT JOIN a o ON o.folder = r.route LEFT JOIN a b ON b.folder = {_UP('r.route')} LEFT JOIN u ON u.up = {_UP('r.route')})
 SELECT o_orderkey, status, CASE WHEN status = 'flat' THEN {_UP('route')} ELSE route END AS destination FROM s"""
)
def folder_resolve(spark, sf_dir):
    routes = materialize(_planned(spark, sf_dir).select("o_orderkey", "route"), "routes")
    up = F.regexp_replace("folder", r"\\?[^\\]*$", "")
    own = routes.where("o_orderkey % 50 = 0").select(F.col("route").alias("folder")).distinct()
    known = own.union(own.where((F.length(up) > 0) & (F.length("folder") % 2 == 0)).select(up)).distinct()
    return folders.resolve(routes, known).select("o_orderkey", "status", "destination")


_PATHS = """SELECT '/docs/' || c_mktsegment || CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '/Forms' ELSE '/_ Closed Accounts _/Bank ' || CAST(c_nationkey AS STRING) END ||
  CASE o_orderkey % 3 WHEN 0 THEN '' ELSE '/' || CAST(year(o_orderdate) AS STRING) END || CASE o_orderkey % 7 WHEN 0 THEN '/sub' ELSE '' END ||
  '/' || CAST(o_orderkey AS STRING) || '.pdf' AS path FROM orders JOIN customer ON o_custkey = c_custkey"""


@query(
    f"""WITH p AS ({_PATHS}), s AS (SELECT path, string_split(substr(path, 7), '/') AS x FROM p), f AS (SELECT path, x[-1] AS name, x[:len(x) - 1] AS d FROM s)
 SELECT path, d[1] AS category, list_filter(d[2:], lambda p: NOT regexp_matches(p, '^(19|20)\\d{{2}}$') AND p NOT IN {_IN(R.NON_ISSUERS)})[-1] AS issuer,
  list_filter(d[2:], lambda p: regexp_matches(p, '^(19|20)\\d{{2}}$'))[-1] AS year, array_to_string(d, '/') AS final_folder, name AS final_filename FROM f"""
)
def infer_label(spark, sf_dir):
    for t in ("orders", "customer"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    found = spark.sql(_PATHS).select("path", R.infer_label(F.col("path"), F.lit("/docs")).alias("l"))
    return found.select("path", "l.category", "l.issuer", "l.year", "l.final_folder", "l.final_filename")


@query(
    """WITH b AS (SELECT o_orderkey, CAST(o_custkey % 20 AS VARCHAR) AS d, strftime(o_orderdate, '%Y.%m') AS s FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY d, s ORDER BY o_orderkey) AS n FROM b)
 SELECT o_orderkey, d AS dest_dir, CASE WHEN n = 1 THEN s || '.pdf' ELSE s || ' - ' || n || '.pdf' END AS resolved FROM r"""
)
def collision_names(spark, sf_dir):
    batch = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 20).cast("string").alias("dest_dir"), F.concat(F.date_format("o_orderdate", "yyyy.MM"), F.lit(".pdf")).alias("filename"), F.col("o_orderkey").alias("batch_index")
    )
    return collisions.resolve(batch).select("o_orderkey", "dest_dir", "resolved")


_BATCH = """SELECT o_orderkey, CAST(o_custkey % 400 AS STRING) AS dest_dir, CAST(1992 + o_orderkey % 2 AS STRING) || CASE o_orderkey % 7
  WHEN 0 THEN ' - ' || CAST(2 + o_orderkey % 4 AS STRING) WHEN 1 THEN ' - 2 - ' || CAST(2 + o_orderkey % 2 AS STRING) ELSE '' END || '.pdf' AS filename FROM orders"""
_THERE = """SELECT CAST(c_custkey % 400 AS STRING) AS dest_dir, CASE c_custkey % 3 WHEN 0 THEN '1992 - ' || CAST(2 + c_custkey % 5 AS STRING) WHEN 1 THEN '1993' ELSE '1992 - 2' END || '.pdf' AS filename
  FROM customer"""


@query(
    f"""WITH RECURSIVE b AS (SELECT *, regexp_extract(filename, '^(.*)[.]pdf$', 1) AS s, row_number() OVER (PARTITION BY dest_dir ORDER BY o_orderkey) AS n FROM ({_BATCH})),
 e AS (SELECT dest_dir, list(filename) AS names FROM ({_THERE}) GROUP BY dest_dir),
 w AS (SELECT d.dest_dir, 0::BIGINT AS n, coalesce(names, []::VARCHAR[]) AS taken, NULL::BIGINT AS o_orderkey, NULL::VARCHAR AS resolved FROM (SELECT DISTINCT dest_dir FROM b) d LEFT JOIN e USING (dest_dir)
  UNION ALL SELECT dest_dir, n, list_append(taken, r) AS taken, o_orderkey, r AS resolved FROM (
   SELECT w.dest_dir, b.n, w.taken, b.o_orderkey, CASE WHEN NOT list_contains(w.taken, b.filename) THEN b.filename ELSE
     list_filter(list_transform(range(2, len(w.taken) + 3), lambda k: b.s || ' - ' || k || '.pdf'), lambda c: NOT list_contains(w.taken, c))[1] END AS r
   FROM w JOIN b ON b.dest_dir = w.dest_dir AND b.n = w.n + 1))
 SELECT o_orderkey, dest_dir, resolved FROM w WHERE n > 0"""
)
def collision_walk(spark, sf_dir):
    """Names that are there already, and names asked for that equal generated ones."""
    for t in ("orders", "customer"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    batch = spark.sql(_BATCH).withColumn("batch_index", F.col("o_orderkey"))
    return collisions.resolve(batch, spark.sql(_THERE)).select("o_orderkey", "dest_dir", "resolved")


# ---------------------------------------------------------------- filters and the log

_FILES = """SELECT CAST(o_custkey % 10 AS STRING) AS parent, CAST(o_orderkey - o_orderkey % 3 AS STRING) || CASE o_orderkey % 3 WHEN 1 THEN '_ocr.pdf' ELSE '.pdf' END AS name,
  o_orderkey FROM orders WHERE o_orderkey % 6 <> 0"""


@query(
    f"""WITH f AS ({_FILES}) SELECT parent, name, o_orderkey FROM f WHERE NOT (name LIKE '%\\_ocr.pdf' ESCAPE '\\' AND EXISTS (
 SELECT 1 FROM f g WHERE g.parent = f.parent AND g.name = replace(f.name, '_ocr.pdf', '.pdf')))"""
)
def ocr_artifact_filter(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return feedback.without_ocr_artifacts(spark.sql(_FILES))


_EVENTS = {"view": "confirmed", "click": "parked", "signup": "skipped", "purchase": "unparked", "error": "rule_added"}
_EVENT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EVENTS.items()) + " END"
LOG_SQL = f"""SELECT event_id AS seq, {_EVENT} AS event, 'f' || CAST(user_id % 5000 AS STRING) || '.pdf' AS original_filename, CAST(ts AS STRING) AS ts,
  CASE WHEN event_id % 11 = 0 THEN ' ' ELSE props END AS text_excerpt, 'c' || CAST(user_id % 7 AS STRING) AS proposed_category,
  CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN NULL ELSE 'c' || CAST(user_id % 9 AS STRING) END AS final_category,
  CASE WHEN event_id % 3 = 0 THEN 'agree' ELSE 'keyword' END AS backend, CAST(event_id AS STRING) AS note FROM events"""
LOG = f"log AS ({LOG_SQL})"


def event_log(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(LOG_SQL)


_PARKED = f"""{LOG}, l AS (SELECT *, row_number() OVER (PARTITION BY original_filename ORDER BY seq DESC) AS n FROM log WHERE event IN {_IN(feedback.PARK_EVENTS)}),
 parked AS (SELECT original_filename, note, seq FROM l WHERE n = 1 AND event = 'parked')"""


@query(f"WITH {_PARKED} SELECT * FROM parked")
def parked_active(spark, sf_dir):
    return feedback.parked(event_log(spark, sf_dir)).select("original_filename", "note", "seq")


_USERS = "SELECT DISTINCT 'f' || CAST(user_id % 5000 AS STRING) || '.pdf' AS name FROM events"


@query(f"WITH {_PARKED}, u AS ({_USERS}) SELECT name FROM u WHERE name NOT IN (SELECT original_filename FROM parked)")
def parked_prefilter(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return feedback.without_parked(spark.sql(_USERS), log)


@query(
    f"""WITH {LOG} SELECT 'total' AS kind, '' AS value, count(*) AS n FROM log UNION ALL SELECT 'event', event, count(*) FROM log GROUP BY event
 UNION ALL SELECT 'category', coalesce(nullif(final_category, ''), nullif(proposed_category, ''), 'Unknown'), count(*) FROM log GROUP BY 2
 UNION ALL SELECT 'backend', backend, count(*) FROM log GROUP BY backend"""
)
def log_stats(spark, sf_dir):
    return feedback.stats(event_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT seq, original_filename FROM log WHERE event = 'parked' ORDER BY seq DESC LIMIT 25")
def log_tail(spark, sf_dir):
    return feedback.tail(event_log(spark, sf_dir), 25, "parked").select("seq", "original_filename")


@query(
    f"""WITH {LOG}, c AS (SELECT coalesce(nullif(final_category, ''), nullif(proposed_category, ''), 'Unknown') AS value, count(*) AS n FROM log GROUP BY 1)
 SELECT value, n FROM c ORDER BY n DESC, value LIMIT 15"""
)
def top_categories(spark, sf_dir):
    return feedback.top_categories(event_log(spark, sf_dir))


HISTORY_SQL = """SELECT 'h' || CAST(o_orderkey % 4 AS STRING) || '.md' AS file, o_orderkey AS line_no,
  CASE WHEN o_orderkey % 97 < 4 THEN '## ' || CAST(1990 + o_orderkey % 31 AS STRING) || '-05-1' || CAST(o_orderkey % 10 AS STRING) || ' — files'
    WHEN o_orderkey % 97 < 8 THEN '## Session 3 — 2020-01-0' || CAST(1 + o_orderkey % 9 AS STRING)
    WHEN o_orderkey % 97 < 12 THEN '## no date here'
    WHEN o_orderkey % 97 < 18 THEN '### 10:3' || CAST(o_orderkey % 10 AS STRING) || ' — 3 file(s) renamed in place'
    WHEN o_orderkey % 97 < 22 THEN '### Duplicates deleted (2)'
    WHEN o_orderkey % 97 < 26 THEN '### another run'
    WHEN o_orderkey % 97 < 28 THEN '| --- | --- | --- | --- | --- | --- | --- |'
    WHEN o_orderkey % 97 < 30 THEN '| 1 | four | cells | only |'
    ELSE '| ' || CAST(o_orderkey % 50 AS STRING) || ' | f' || CAST(o_custkey % 300 AS STRING) || '.pdf' || CASE o_orderkey % 5 WHEN 0 THEN ' (OCR)' ELSE '' END ||
      ' | Bills \\\\| more | ' || CASE o_orderkey % 3 WHEN 0 THEN '—' ELSE 'FPL' END || ' | ' || CASE o_orderkey % 4 WHEN 0 THEN 'same' ELSE 'new name.pdf' END ||
      ' | ' || CASE o_orderkey % 6 WHEN 0 THEN '-' ELSE '$1.00' END || ' | ' || CASE o_orderkey % 13 WHEN 0 THEN 'Deleted' ELSE 'Bills/FPL' END || ' |' END AS line
  FROM orders"""


def history_lines(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(HISTORY_SQL)


_EMPTY = _IN(history.EMPTY_CELLS)
PARSED_SQL = f"""lines AS ({HISTORY_SQL.replace(chr(92) * 2, chr(92))}),
 h1 AS (SELECT *, coalesce(nullif(regexp_extract(line, '^##\\s+(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1), ''), nullif(regexp_extract(line, '^##\\s+.*?(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '')) AS nd,
   line LIKE '###%' AS hd, regexp_matches(line, '(?i)^###\\s+(Duplicates deleted|Renamed in destination|Skipped|Pending iteration)') AS sk FROM lines),
 h2 AS (SELECT *, CASE WHEN nd IS NOT NULL THEN 'move' WHEN hd AND NOT sk THEN CASE WHEN line LIKE '%renamed in place' THEN 'rename' ELSE 'move' END END AS na,
   CASE WHEN nd IS NOT NULL OR hd AND NOT sk THEN false WHEN hd THEN true END AS ns FROM h1),
 h3 AS (SELECT *, last_value(nd IGNORE NULLS) OVER w AS day, last_value(na IGNORE NULLS) OVER w AS act, last_value(ns IGNORE NULLS) OVER w AS skip
   FROM h2 WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 h4 AS (SELECT file, line_no, coalesce(day, '') AS day, coalesce(act, 'move') AS action_mode,
   list_transform(string_split(trim(replace(line, '\\|', chr(1)), '|'), '|'), lambda c: replace(trim(c), chr(1), '|')) AS c
   FROM h3 WHERE NOT coalesce(skip, false) AND line LIKE '|%'),
 parsed AS (SELECT file, line_no, trim(regexp_replace(c[2], '\\s*\\([^)]+\\)\\s*$', '')) AS original_filename, c[3] AS category,
   CASE WHEN c[4] NOT IN {_EMPTY} THEN c[4] END AS issuer,
   CASE WHEN lower(c[5]) IN {_EMPTY} THEN trim(regexp_replace(c[2], '\\s*\\([^)]+\\)\\s*$', '')) ELSE c[5] END AS new_filename, c[7] AS destination,
   CASE WHEN c[6] NOT IN {_EMPTY} THEN c[6] END AS amount, day, action_mode
   FROM h4 WHERE len(c) >= 7 AND regexp_matches(c[1], '^-*[0-9]+$') AND NOT regexp_matches(upper(c[7]), 'DELETED|DUPLICATE'))"""


@query(f"WITH {PARSED_SQL} SELECT * FROM parsed")
def history_parse(spark, sf_dir):
    return history.parse(history_lines(spark, sf_dir))


_LATEST = f"""{PARSED_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY original_filename ORDER BY day DESC, file DESC, line_no DESC) AS rn FROM parsed),
 latest AS (SELECT original_filename, category, issuer, destination, day, line_no FROM ranked WHERE rn = 1)"""


@query(f"WITH {_LATEST} SELECT * FROM latest")
def history_latest(spark, sf_dir):
    found = history.latest(history.parse(history_lines(spark, sf_dir)))
    return found.select("original_filename", "category", "issuer", "destination", "day", "line_no")


_NAMES = """SELECT 'f' || CAST(c_custkey % 400 AS STRING) || '.pdf' AS name, c_custkey, CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE 'text' END AS text,
 c_custkey % 6 = 0 AS ocr_run, c_custkey % 12 = 0 AS ocr_failed, CASE WHEN c_custkey % 50 = 0 THEN 'bad file' END AS error FROM customer"""
_LOGGED = "SELECT DISTINCT 'f' || CAST(c_custkey * 7 % 400 AS STRING) || '.pdf' AS original_filename FROM customer WHERE c_custkey % 25 = 0"
_OUTCOMES = f"""{_LATEST}, names AS ({_NAMES}), logged AS ({_LOGGED}),
 outcomes AS (SELECT *, CASE WHEN name IN (SELECT original_filename FROM logged) THEN 'already_logged'
  WHEN name IN (SELECT original_filename FROM latest) THEN 'matched' ELSE 'no_history_match' END AS outcome FROM names)"""


def _outcomes(spark, sf_dir) -> DataFrame:
    entries = history.latest(history.parse(history_lines(spark, sf_dir)))
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return feedback.bootstrap_outcomes(spark.sql(_NAMES), entries, spark.sql(_LOGGED))


@query(f"WITH {_OUTCOMES} SELECT c_custkey, outcome FROM outcomes")
def bootstrap_join(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("c_custkey", "outcome")


@query(
    f"""WITH {_OUTCOMES} SELECT count(*) AS scanned, count(*) FILTER (outcome = 'matched') AS matched, count(*) FILTER (outcome = 'matched') AS appended,
 count(*) FILTER (outcome = 'already_logged') AS already_logged, count(*) FILTER (outcome = 'no_history_match') AS no_history_match,
 count(*) FILTER (outcome = 'matched' AND text = 'text') AS text_extracted, count(*) FILTER (outcome = 'matched' AND ocr_run) AS ocr_run,
 count(*) FILTER (outcome = 'matched' AND ocr_failed) AS ocr_failed, count(*) FILTER (outcome = 'matched' AND error IS NOT NULL) AS errors FROM outcomes"""
)
def bootstrap_counters(spark, sf_dir):
    return feedback.bootstrap_counters(_outcomes(spark, sf_dir))


# ---------------------------------------------------------------- vectors

_COS = "CASE WHEN list_dot_product(a.v, b.v) IS NULL THEN 0 ELSE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) END"
_VEC = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _query_vector(spark, sf_dir, i: int):
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == i).select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in row.embedding])


@query(f"WITH {_VEC} SELECT a.vec_id, round({_COS}, 6) AS score FROM e a, e b WHERE b.vec_id = 7 ORDER BY round({_COS}, 9) DESC, a.vec_id LIMIT 5")
def knn_top5(spark, sf_dir):
    found = vectors.search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir, 7), k=5)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC} SELECT a.vec_id, round({_COS}, 6) AS score FROM e a, e b WHERE b.vec_id = 7 AND a.label = 3 ORDER BY round({_COS}, 9) DESC, a.vec_id LIMIT 5")
def knn_by_category(spark, sf_dir):
    examples = table(spark, sf_dir, "embeddings").withColumn("category", F.col("label").cast("string"))
    return vectors.search(examples, _query_vector(spark, sf_dir, 7), k=5, category="3").select("vec_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_VEC}, s AS (SELECT b.vec_id AS query_id, a.vec_id, {_COS} AS score FROM e a, e b WHERE b.vec_id % 50 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s)
 SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""
)
def knn_batch(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.search_batch(e, queries, k=5).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_STORE = "SELECT 'f' || CAST(vec_id AS STRING) AS original_filename, CAST(vec_id % 3 AS STRING) AS ts, CAST(label AS STRING) AS category, vec_id AS n FROM embeddings WHERE vec_id % 2 = 0"
_LATER = "SELECT 'f' || CAST(vec_id AS STRING) AS original_filename, CAST(vec_id % 3 AS STRING) AS ts, 'new' AS category, -vec_id AS n FROM embeddings WHERE vec_id % 3 = 0"


@query(f"WITH s AS ({_STORE}), l AS ({_LATER}) SELECT * FROM l UNION ALL SELECT * FROM s WHERE (original_filename, ts) NOT IN (SELECT (original_filename, ts) FROM l)")
def vector_upsert(spark, sf_dir):
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("embeddings")
    return vectors.upsert(spark.sql(_STORE), spark.sql(_LATER))


@query("SELECT coalesce(nullif(CAST(label AS VARCHAR), ''), '(none)') AS category, count(*) AS n FROM embeddings GROUP BY 1")
def store_stats(spark, sf_dir):
    return vectors.stats(table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("category")))


_INDEXED = "SELECT original_filename, ts FROM log WHERE seq % 5 = 0"


@query(
    f"""WITH {LOG}, k AS (SELECT DISTINCT original_filename, ts FROM ({_INDEXED})),
 o AS (SELECT CASE WHEN event <> 'confirmed' THEN 'skipped_event' WHEN k.ts IS NOT NULL THEN 'skipped_existing' WHEN trim(text_excerpt) = '' THEN 'skipped_empty'
  WHEN length(trim(text_excerpt)) % 5 = 0 THEN 'error' ELSE 'embedded' END AS x
  FROM log LEFT JOIN k ON k.original_filename = log.original_filename AND k.ts = log.ts)
 SELECT count(*) AS seen, count(*) FILTER (x = 'skipped_event') AS skipped_event, count(*) FILTER (x = 'skipped_existing') AS skipped_existing,
  count(*) FILTER (x = 'skipped_empty') AS skipped_empty, count(*) FILTER (x = 'embedded') AS embedded, count(*) FILTER (x = 'error') AS errors FROM o"""
)
def index_incremental(spark, sf_dir):
    """What a run over the log does, with an embedder that fails on some texts."""
    log, store = _indexing(spark, sf_dir)
    return vectors.index_counters(vectors.indexed(log, store, _failing)[1])


def _failing(text):
    """Vectors that need no service; none for some texts."""
    return F.when(F.length(text) % 5 != 0, F.array(F.length(text).cast("float"), F.lit(1.0).cast("float")))


def _indexing(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    log = event_log(spark, sf_dir)
    for c in ("issuer", "folder", "filename"):
        log = log.withColumn(f"final_{c}", F.lit(None).cast("string")).withColumn(f"proposed_{c}", F.concat(F.lit(c[0]), F.col("note")))
    kept = log.where("seq % 5 = 0").select("original_filename", "ts", F.lit(0).cast("long").alias("seq"), F.lit("kept").alias("category"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    return log, kept.dropDuplicates(["original_filename", "ts"])


@query(
    f"""WITH {LOG}, k AS (SELECT DISTINCT original_filename, ts FROM ({_INDEXED})),
 o AS (SELECT log.*, length(trim(text_excerpt)) % 5 = 0 AS late FROM log LEFT JOIN k ON k.original_filename = log.original_filename AND k.ts = log.ts
  WHERE event = 'confirmed' AND k.ts IS NULL AND trim(text_excerpt) <> ''),
 b AS (SELECT *, bool_or(NOT late) OVER (PARTITION BY original_filename, ts) AS early FROM o),
 r AS (SELECT * FROM b WHERE late <> early QUALIFY row_number() OVER (PARTITION BY original_filename, ts ORDER BY seq DESC) = 1)
 SELECT original_filename, ts, coalesce(nullif(final_category, ''), proposed_category) AS category, 'i' || note AS issuer, 'f' || note AS folder, 'f' || note AS final_filename,
  CAST(length(trim(text_excerpt)) AS INTEGER) AS size FROM r UNION ALL SELECT original_filename, ts, 'kept', NULL, NULL, NULL, 1 FROM k"""
)
def index_stored(spark, sf_dir):
    """The store after a run in which some texts failed, and one in which they did not."""
    log, store = _indexing(spark, sf_dir)
    after = vectors.index(log, store, _failing)
    every = lambda text: F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))
    done = vectors.index(log, materialize(after, "store"), every)
    return done.select("original_filename", "ts", "category", "issuer", "folder", "final_filename", F.col("embedding")[0].cast("int").alias("size"))


# ---------------------------------------------------------------- second opinion and evaluation

_OPINION = "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE lang END"
_TRUST = "CAST((doc_id % 10) AS DOUBLE) / 10"


def _samples(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("truth_category"), F.when(F.col("doc_id") % 17 != 0, F.col("text")).otherwise(F.lit("")).alias("text"),
        (F.col("doc_id") % 100).alias("llm_duration_ms"), F.expr(_OPINION).alias("llm_category"), F.lit(None).cast("string").alias("llm_issuer"), F.expr(_TRUST).alias("llm_confidence"),
    )


_AUDIT = f"""d AS (SELECT doc_id, lang, CASE WHEN doc_id % 17 <> 0 THEN text ELSE '' END AS text, {_OPINION} AS llm, {_TRUST} AS conf FROM documents),
 k AS ({_category_sql('d', 'text', LANGUAGES, 2)}),
 a AS (SELECT CAST(doc_id AS VARCHAR) AS path, lang AS truth_category, CASE WHEN text = '' THEN 'no_text' END AS skipped,
   CASE WHEN text <> '' THEN category END AS keyword_category, CASE WHEN text <> '' THEN category = lang END AS keyword_correct,
   CASE WHEN text <> '' AND llm IS NOT NULL THEN llm = lang END AS llm_correct,
   CASE WHEN text <> '' THEN CASE WHEN llm IS NULL OR conf < 0.6 OR llm = category THEN category ELSE llm END END AS hybrid_category,
   CASE WHEN text <> '' THEN CASE WHEN llm IS NULL THEN 'keyword' WHEN conf < 0.6 THEN 'keyword-llm-low-conf' WHEN llm = category THEN 'agree'
     WHEN category = 'Uncategorized' THEN 'hybrid-llm' ELSE 'hybrid-llm-disagree' END END AS hybrid_backend FROM k),
 audit AS (SELECT *, CASE WHEN skipped IS NULL THEN hybrid_category = truth_category END AS hybrid_correct FROM a)"""


def _audit(spark, sf_dir) -> DataFrame:
    return evaluation.evaluate(_samples(spark, sf_dir), config=LANGUAGE_CONFIG)


@query(f"WITH {_AUDIT} SELECT path, keyword_category, keyword_correct, llm_correct, hybrid_category, hybrid_backend, hybrid_correct, skipped FROM audit")
def second_opinion_decision(spark, sf_dir):
    return _audit(spark, sf_dir).select("path", "keyword_category", "keyword_correct", "llm_correct", "hybrid_category", "hybrid_backend", "hybrid_correct", "skipped")


@query(
    f"""WITH {_AUDIT} SELECT count(*) AS n_total, count(*) FILTER (skipped IS NULL) AS n_evaluated, count(*) FILTER (skipped IS NOT NULL) AS n_skipped,
 count(llm_correct) AS llm_attempted, count(*) FILTER (keyword_correct) AS keyword_correct, count(*) FILTER (llm_correct) AS llm_correct, count(*) FILTER (hybrid_correct) AS hybrid_correct,
 count(*) FILTER (keyword_correct) / count(*) FILTER (skipped IS NULL)::DOUBLE AS keyword_accuracy, count(*) FILTER (llm_correct) / count(llm_correct)::DOUBLE AS llm_accuracy,
 count(*) FILTER (hybrid_correct) / count(*) FILTER (skipped IS NULL)::DOUBLE AS hybrid_accuracy,
 CAST(sum(CAST(path AS BIGINT) % 100) FILTER (skipped IS NULL) AS DOUBLE) / count(llm_correct)::DOUBLE AS llm_mean_ms FROM audit"""
)
def eval_overall(spark, sf_dir):
    return evaluation.overall(_audit(spark, sf_dir))


@query(
    f"""WITH {_AUDIT} SELECT truth_category, count(*) AS n, count(*) FILTER (keyword_correct) AS keyword_correct, count(*) FILTER (llm_correct) AS llm_correct,
 count(*) FILTER (hybrid_correct) AS hybrid_correct FROM audit WHERE skipped IS NULL GROUP BY truth_category"""
)
def eval_by_category(spark, sf_dir):
    return evaluation.by_category(_audit(spark, sf_dir))


@query(f"WITH {_AUDIT} SELECT truth_category AS truth, coalesce(hybrid_category, '(none)') AS predicted, count(*) AS n FROM audit WHERE skipped IS NULL GROUP BY 1, 2")
def eval_confusion(spark, sf_dir):
    return evaluation.confusion(_audit(spark, sf_dir))


@query(
    f"WITH {_AUDIT} SELECT path, CASE WHEN llm_correct THEN 'helped' ELSE 'hurt' END AS effect FROM audit WHERE skipped IS NULL AND llm_correct IS NOT NULL AND llm_correct <> keyword_correct"
)
def eval_helped_hurt(spark, sf_dir):
    return evaluation.helped_and_hurt(_audit(spark, sf_dir)).select("path", "effect")


@query(f"WITH {_AUDIT} SELECT skipped, count(*) AS n FROM audit WHERE skipped IS NOT NULL GROUP BY skipped")
def eval_skip_reasons(spark, sf_dir):
    return evaluation.skip_reasons(_audit(spark, sf_dir))


@query(
    """WITH d AS (SELECT doc_id, lang, md5('42:' || CAST(doc_id AS VARCHAR)) AS h, count(*) OVER (PARTITION BY lang) AS size, count(*) OVER () AS total FROM documents),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS place FROM d),
 c AS (SELECT * FROM r WHERE total <= 200 OR place <= greatest(1, round_even(200 * size / total, 0)))
 SELECT doc_id, lang FROM c ORDER BY h, doc_id LIMIT 200"""
)
def stratified_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return evaluation.stratified_sample(docs, "lang", "doc_id", 200).select("doc_id", "lang")


@query(
    f"""WITH {_AUDIT} SELECT path, CASE WHEN llm IS NULL THEN 'keyword' WHEN hybrid_backend LIKE 'hybrid-llm%' THEN 'LLM ✱ ' || c WHEN hybrid_backend = 'keyword-llm-low-conf' THEN 'kw (LLM low) ' || c
  WHEN keyword_category = llm THEN 'agree ✓ ' || c ELSE 'kw LLM ' || c END AS badge
 FROM (SELECT *, {_OPINION.replace('doc_id', 'CAST(path AS BIGINT)').replace('lang', 'truth_category')} AS llm,
  printf('%.2f', {_TRUST.replace('doc_id', 'CAST(path AS BIGINT)')}) AS c FROM audit) WHERE skipped IS NULL"""
)
def backend_badges(spark, sf_dir):
    a = _audit(spark, sf_dir).where("skipped is null")
    badge = R.backend_badge(F.col("hybrid_backend"), F.col("keyword_category"), F.col("llm_category"), F.col("llm_confidence"), F.lit(None).cast("string"))
    return a.select("path", badge.alias("badge"))


@query(f"WITH p AS ({_PATHS}) SELECT path, CASE WHEN path LIKE '/docs/MACHINERY/%' THEN substr(path, 17) ELSE path END AS relative FROM p")
def relative_path(spark, sf_dir):
    for t in ("orders", "customer"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(_PATHS).select("path", R.relative_path(F.col("path"), F.lit("/docs/MACHINERY")).alias("relative"))


_RULES = "SELECT DISTINCT c_mktsegment AS category, CAST(c_nationkey AS STRING) AS keyword FROM customer WHERE c_custkey %s 3 = %s"


@query(f"WITH a AS ({_RULES % ('%', 0)}), b AS ({_RULES % ('%', 1)}) SELECT * FROM a UNION SELECT * FROM b")
def keyword_rules_merged(spark, sf_dir):
    """Keywords appended where absent; rules are few, a category and a nation each."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    rules = [spark.sql(_RULES % ("%", i)).groupBy("category").agg(F.sort_array(F.collect_set("keyword")).alias("words")).collect() for i in (0, 1)]
    held, new = ({r.category: tuple(r.words) for r in found} for found in rules)
    merged = C.RoutingConfig(categories=held).with_rules(keywords=new).categories
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(w).alias("keyword")) for c, words in merged.items() for w in words])
    return spark.range(1).select(F.inline(rows.cast("array<struct<category: string, keyword: string>>")))


# ---------------------------------------------------------------- prompts and replies

_TRIMMED = "trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


@query(
    f"""SELECT doc_id, sha256(CASE WHEN length({_TRIMMED}) <= 3500 THEN {_TRIMMED} ELSE left({_TRIMMED}, 2500) || chr(10) || '…[' || (length({_TRIMMED}) - 3500) || ' chars omitted]…' || chr(10) || right({_TRIMMED}, 1000) END) AS excerpt
 FROM documents"""
)
def excerpt_trim(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(L.excerpt(F.col("text")), 256).alias("excerpt"))


def _stub_vector(text: str) -> str:
    """The stub's vector of a text: bytes of its digest from -1 to 1, as floats of unit length."""
    raw = f"list_transform(range(16), lambda i: CAST(('0x' || substr(sha256({text}), 2 * i + 1, 2)) AS INTEGER) / 127.5::DOUBLE - 1.0::DOUBLE)"
    return f"list_transform([{raw}], lambda v: list_transform(v, lambda x: CAST(CAST(x / sqrt(list_dot_product(v, v)) AS FLOAT) AS DOUBLE)))[1]"


_NL = "chr(10)"
_EXCERPT = f"""CASE WHEN length({_TRIMMED}) <= 3500 THEN {_TRIMMED}
  ELSE left({_TRIMMED}, 2500) || {_NL} || '…[' || (length({_TRIMMED}) - 3500) || ' chars omitted]…' || {_NL} || right({_TRIMMED}, 1000) END"""
_NEAREST = f"""d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents),
 e AS (SELECT doc_id, {_stub_vector("left(trim(text), 6000)")} AS v, {_stub_vector("left(text, 2500)")} AS q FROM d WHERE trim(text) <> ''),
 s AS (SELECT x.doc_id, y.doc_id AS other, round(list_dot_product(x.q, y.v) / (sqrt(list_dot_product(x.q, x.q)) * sqrt(list_dot_product(y.v, y.v))), 12) AS score
  FROM e x JOIN e y ON @PAIRS@),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, other) AS n FROM s QUALIFY n <= 5)"""
def _literal_sql(text: str) -> str:
    """A quoted literal, character by character."""
    hexed = "'\\' || CASE WHEN unicode(c) < 256 THEN printf('x%02x', unicode(c)) WHEN unicode(c) < 65536 THEN printf('u%04x', unicode(c)) ELSE printf('U%08x', unicode(c)) END"
    quote = "CASE WHEN contains(s, chr(39)) AND NOT contains(s, chr(34)) THEN chr(34) ELSE chr(39) END"
    one = f"""CASE c WHEN '\\' THEN '\\\\' WHEN chr(10) THEN '\\n' WHEN chr(13) THEN '\\r' WHEN chr(9) THEN '\\t' WHEN ' ' THEN c
   ELSE CASE WHEN c = chr(39) AND {quote} = c THEN '\\' || c WHEN regexp_matches(c, '[\\p{{C}}\\p{{Z}}]') THEN {hexed} ELSE c END END"""
    return f"coalesce(list_transform([{text}], lambda s: CASE WHEN s IS NOT NULL THEN {quote} || array_to_string([{one} FOR c IN string_split(s, '')], '') || {quote} END)[1], 'None')"


_LINE = f"""list_transform([replace(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), {_NL}, ' ')], lambda t: '- Text: ' ||
  {_literal_sql("CASE WHEN length(t) > 400 THEN left(t, 400) || '…' ELSE t END")} || {_NL} || '  → category=' || {_literal_sql('lang')} || ', issuer=' || {_literal_sql("coalesce(nullif(source, ''), '—')")})[1]"""
_QUOTES = '"' * 3


@query(
    f"""WITH {_NEAREST.replace('@PAIRS@', 'y.doc_id < x.doc_id')},
 l AS (SELECT doc_id, {_LINE} AS line FROM d),
 shots AS (SELECT r.doc_id, count(*) AS k, string_agg(line, {_NL} ORDER BY n) AS lines FROM r JOIN l ON l.doc_id = r.other GROUP BY r.doc_id),
 known AS (SELECT list_sort(list(DISTINCT source) FILTER (source IS NOT NULL))[:30] AS names FROM documents),
 p AS (SELECT d.doc_id, coalesce('Past confirmed decisions on the ' || k || ' most similar documents:' || {_NL} || lines || {_NL} || {_NL}, '') ||
   CASE WHEN len(names) > 0 THEN 'Known issuer names: ' || array_to_string(names, ', ') || {_NL} || {_NL} ELSE '' END ||
   'Filename: ' || d.doc_id || '.pdf' || {_NL} || 'Document text:' || {_NL} || '{_QUOTES}' || {_NL} || {_EXCERPT} || {_NL} || '{_QUOTES}' || {_NL} || {_NL} || 'Return the JSON object.' AS prompt
  FROM d LEFT JOIN shots USING (doc_id), known)
 SELECT doc_id, CAST(length(prompt) AS INTEGER) AS prompt_chars, sha256(prompt) AS prompt FROM p"""
)
def prompt_build(spark, sf_dir):
    """Prompts with the nearest earlier decisions as examples, by stub vectors."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    line = L.neighbour_line(F.col("text"), F.col("lang"), F.col("source"))
    shots = vectors.few_shots(docs, docs, backends.stub_embedding(), line)
    names = docs.select("source").where("source is not null").distinct().orderBy("source").limit(30)  # as many as a prompt holds
    issuers = names.agg(F.collect_set("source").alias("issuers"))
    prompt = L.user_prompt(F.col("text"), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")), F.col("shots"), F.col("issuers"))
    return docs.join(shots, "doc_id", "left").crossJoin(F.broadcast(issuers)).select("doc_id", F.length(prompt).alias("prompt_chars"), F.sha2(prompt, 256).alias("prompt"))


@query(
    f"""WITH {_NEAREST.replace('@PAIRS@', 'true')}, k AS (SELECT doc_id, count(*) AS shots FROM r GROUP BY doc_id),
 b AS (SELECT d.doc_id, coalesce(shots, 0) AS shots, r.doc_id IS NOT NULL AS has, coalesce(o.lang, 'None') AS lang, coalesce(nullif(trim(o.source), ''), '—') AS source
  FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r ON r.doc_id = d.doc_id AND r.n = 1 LEFT JOIN d o ON o.doc_id = r.other)
 SELECT doc_id, CASE WHEN has AND lang IN {_IN(LANGUAGES)} THEN lang END AS llm_category,
  CASE WHEN has AND lang IN {_IN(LANGUAGES)} AND lower(source) NOT IN {_IN(L.NO_ISSUER)} THEN source END AS llm_issuer,
  CASE WHEN has AND lang IN {_IN(LANGUAGES)} THEN 0.9::DOUBLE END AS llm_confidence,
  CASE WHEN NOT has THEN 'no example' WHEN lang NOT IN {_IN(LANGUAGES)} THEN 'category not allowed: ' || lang END AS llm_error,
  CAST(shots AS INTEGER) AS llm_fewshot_count FROM b"""
)
def llm_classify(spark, sf_dir):
    """Every document judged with its nearest stored decisions in the prompt, by a back end that echoes the first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"))
    embed = backends.stub_embedding()
    text = F.coalesce(F.col("text"), F.lit(""))
    stored = table(spark, sf_dir, "documents").where(F.trim(text) != "")
    stored = stored.select(
        F.col("doc_id").alias("vec_id"), embed(F.left(F.trim(text), F.lit(6000))).alias("embedding"), F.col("text").alias("text_excerpt"),
        F.col("lang").alias("category"), F.col("source").alias("issuer"),
    )
    judged = P.second_opinions(docs, stored, embed, backends.EchoOpinion(), config=LANGUAGE_CONFIG)
    return judged.select("doc_id", "llm_category", "llm_issuer", "llm_confidence", "llm_error", "llm_fewshot_count")


# ---------------------------------------------------------------- a batch from files to destinations

_LISTED = f"SELECT parent, name, o_orderkey, parent || '/' || name || '/' || CAST(o_orderkey AS STRING) AS path FROM ({_FILES})"
_HELD = """SELECT o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'parked' WHEN 1 THEN 'unparked' ELSE 'rule_added' END AS event,
 CAST(o_orderkey % 997 AS STRING) || '.pdf' AS original_filename, '' AS ts, '' AS note FROM orders"""
_OFF = f"""held AS ({_HELD}), hl AS (SELECT *, row_number() OVER (PARTITION BY original_filename ORDER BY seq DESC) AS n FROM held WHERE event <> 'rule_added'),
 off AS (SELECT original_filename FROM hl WHERE n = 1 AND event = 'parked')"""


@query(
    f"""WITH f AS ({_LISTED}), {_OFF},
 k AS (SELECT path, name, o_orderkey FROM f WHERE NOT (name LIKE '%\\_ocr.pdf' ESCAPE '\\' AND EXISTS (SELECT 1 FROM f g WHERE g.parent = f.parent AND g.name = replace(f.name, '_ocr.pdf', '.pdf')))
  AND name NOT IN (SELECT original_filename FROM off))
 SELECT path, name, o_orderkey, row_number() OVER (ORDER BY path) AS "index" FROM k ORDER BY path LIMIT 1000"""
)
def process_batch(spark, sf_dir):
    """What a run takes up: no artefacts, nothing parked, the first 1000 by path, numbered."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    taken = feedback.batch(spark.sql(_LISTED), spark.sql(_HELD), max_files=1000)
    return taken.select("path", "name", "o_orderkey", "index")


@query(
    f"""WITH {META}, {_OFF},
 f AS (SELECT *, CAST(o_orderkey AS STRING) || '/' || filename AS path FROM meta WHERE filename NOT IN (SELECT original_filename FROM off)),
 i AS (SELECT *, row_number() OVER (ORDER BY path) AS "index" FROM f),
 p AS (SELECT o_orderkey, "index", category, {_ROUTE} AS destination, {_NAME} AS new_name FROM i WHERE o_orderkey % 13 <> 0),
 c AS (SELECT *, row_number() OVER (PARTITION BY destination, new_name ORDER BY "index") AS n FROM p)
 SELECT o_orderkey, "index", category, destination,
  CASE WHEN n = 1 THEN new_name ELSE regexp_replace(new_name, '[.][^./]+$', '') || ' - ' || n || regexp_extract(new_name, '[.][^./]+$') END AS final_name FROM c"""
)
def process_plan(spark, sf_dir):
    """Files to proposals in one call; files without text leave gaps in the numbers."""
    made = statements(spark, sf_dir)
    key = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 13 != 0, F.col("text")).otherwise(F.lit(""))
    files = made.select("o_orderkey", key.alias("parent"), F.col("filename").alias("name"), F.concat_ws("/", key, "filename").alias("path"), text.alias("text"))
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    proposals, _ = P.process(files, spark.sql(_HELD))
    return proposals.select("o_orderkey", "index", "category", "destination", "final_name")


_KINDS = "SELECT o_orderkey * 2 AS file_index, CASE o_orderkey % 3 WHEN 0 THEN 'issuer' WHEN 1 THEN 'category' ELSE 'other' END AS kind, o_orderstatus AS value FROM orders"


@query(
    f"""WITH {STMT}, k AS ({_KINDS}), s AS (SELECT o_orderkey, lower({_STEM}) AS stem FROM stmt)
 SELECT o_orderkey AS "index", kind, CASE kind WHEN 'issuer' THEN stem ELSE replace(replace(stem, '-', ' '), '_', ' ') END AS key, value
 FROM s JOIN k ON file_index = o_orderkey WHERE kind <> 'other'"""
)
def intent_rules(spark, sf_dir):
    planned = statements(spark, sf_dir).select(F.col("o_orderkey").alias("index"), F.col("filename").alias("name"))
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return P.intent_rules(planned, spark.sql(_KINDS))


def _summary_sql() -> str:
    date, money = "coalesce(left(date, 10), '')", "currency || CAST(try_cast(amount AS DECIMAL(38,2)) AS VARCHAR)"
    cases = []
    for name, (text, before) in R.SUMMARIES.items():
        made = f"'{text}'"
        for k, v in (("issuer", "coalesce(issuer, '')"), ("date", date), ("year", f"left({date}, 4)")):
            made = f"replace({made}, '{{{k}}}', {v})"
        cases.append(f"WHEN '{name}' THEN {made}" + (f" || coalesce('{before}' || {money}, '')" if before else ""))
    return f"trim(CASE category {' '.join(cases)} ELSE category || ' document — ' || {date} END, ' —')"


@query(f"WITH {META} SELECT o_orderkey, {_summary_sql()} AS summary FROM meta")
def content_summaries(spark, sf_dir):
    p = _planned(spark, sf_dir)
    return p.select("o_orderkey", R.content_summary(F.col("category"), F.col("metadata")).alias("summary"))


_FAR = """SELECT o_orderkey, 'DOB' || repeat('x', CAST(o_orderkey % 260 AS INT)) || ' 01/02/1970, ' || repeat('y', 300) || '3-4-1980 ' || repeat('z', CAST(o_orderkey % 217 AS INT)) || ' born on' AS text FROM orders"""


@query(
    f"""WITH f AS ({_FAR}) SELECT o_orderkey, sha256('DOB' || repeat('x', CAST(o_orderkey % 260 AS INT)) || ' ' || CASE WHEN 4 + o_orderkey % 260 <= 200 THEN repeat(' ', 10) ELSE '01/02/1970' END || ', ' ||
 repeat('y', 300) || CASE WHEN 10 + o_orderkey % 217 <= 200 THEN repeat(' ', 8) ELSE '3-4-1980' END || ' ' || repeat('z', CAST(o_orderkey % 217 AS INT)) || ' born on') AS blanked FROM f"""
)
def dob_distance(spark, sf_dir):
    """Dates up to 200 characters from a label are blanked, on either side, and those farther are not."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(_FAR).select("o_orderkey", F.sha2(X.without_birth_dates(F.col("text")), 256).alias("blanked"))


@query("SELECT count(*) AS total, CAST(arg_min(len(embedding), vec_id) AS INTEGER) AS dim, arg_min('m' || label, vec_id) AS embed_model FROM embeddings")
def store_info(spark, sf_dir):
    store = table(spark, sf_dir, "embeddings").withColumn("embed_model", F.concat(F.lit("m"), F.col("label").cast("string")))
    return vectors.store_info(store, ("vec_id",))


_ANSWER = """CASE doc_id % 6 WHEN 0 THEN '{"category": " ' || lang || ' ", "issuer": "N/A", "confidence": 0.5, "reasons": ["a ", " "], "more": 1}'
  WHEN 1 THEN '{"category": "' || lang || '", "issuer": " Bank ", "confidence": 1, "reasons": "short"}' WHEN 2 THEN '{"category": "xx", "confidence": 0.25}'
  WHEN 3 THEN '{"category": "' || lang || '", "confidence": 1.5}' WHEN 4 THEN '{"issuer": "x", "confidence": 0.5}' ELSE 'no json' END"""


@query(
    """SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1) THEN lang END AS category, CASE doc_id % 6 WHEN 1 THEN 'Bank' END AS issuer,
 CASE doc_id % 6 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 END::DOUBLE AS confidence, CASE doc_id % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'short' END AS reasons,
 CASE doc_id % 6 WHEN 2 THEN 'category not allowed: xx' WHEN 3 THEN 'no confidence from 0 to 1' WHEN 4 THEN 'no category' WHEN 5 THEN 'no JSON object' END AS error FROM documents"""
)
def verdict_parse(spark, sf_dir):
    allowed = F.array(*[F.lit(x) for x in LANGUAGES])
    v = table(spark, sf_dir, "documents").select("doc_id", L.verdict(F.expr(_ANSWER.replace("\\", "")), allowed).alias("v"))
    return v.select("doc_id", "v.category", "v.issuer", "v.confidence", F.array_join("v.reasons", ";").alias("reasons"), "v.error")


_REPLY = """CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'skip 2, 4 Note: not mine' WHEN 2 THEN 'PARK 3 9 note:later' WHEN 3 THEN '1,3 x5' ELSE 'q' END"""


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '1,2,3,4,5' WHEN 1 THEN '1,3,5' WHEN 2 THEN '1,2,4,5' WHEN 3 THEN '1,3' ELSE '' END AS approved,
 CASE doc_id % 5 WHEN 2 THEN '3' ELSE '' END AS parked, CASE doc_id % 5 WHEN 1 THEN 'not mine' WHEN 2 THEN 'later' ELSE '' END AS note FROM documents"""
)
def confirm_literal(spark, sf_dir):
    valid = F.array(*[F.lit(i) for i in range(1, 6)])
    r = table(spark, sf_dir, "documents").select("doc_id", L.literal_reply(F.expr(_REPLY), valid).alias("r"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return r.select("doc_id", text(F.col("r.approved")).alias("approved"), text(F.col("r.parked")).alias("parked"), "r.note")


_INTENT = """CASE doc_id % 4 WHEN 0 THEN '{"action": "skip_some", "indices": ["2", 9, "x"], "note": " why ", "file_notes": [{"file_index": 2, "note": "own"}, {"file_index": 8, "note": "no"}], "rules": [{"file_index": 2, "kind": "issuer", "value": "FPL"}, {"file_index": 2, "kind": "other", "value": "x"}]}'
  WHEN 1 THEN '{"action": "park_some", "indices": [7]}' WHEN 2 THEN '{"action": "dance"}' ELSE '{"action": "move_all"}' END"""


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'skip_some' WHEN 3 THEN 'move_all' END AS action, CASE doc_id % 4 WHEN 0 THEN '2' WHEN 3 THEN '' END AS indices,
 CASE doc_id % 4 WHEN 0 THEN 'own' WHEN 3 THEN '' END AS note_2, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 3 THEN 0 END::BIGINT AS n_rules,
 CASE doc_id % 4 WHEN 1 THEN 'no valid indices' WHEN 2 THEN 'no valid action' END AS error FROM documents"""
)
def intent_parse(spark, sf_dir):
    valid = F.array(*[F.lit(i) for i in range(1, 6)])
    p = table(spark, sf_dir, "documents").select("doc_id", L.intent(F.expr(_INTENT), valid).alias("p"))
    indices = F.array_join(F.transform("p.indices", lambda x: x.cast("string")), ",")
    note = L.note_for(F.lit(2), F.col("p.file_notes"), F.col("p.note"))
    n_rules = F.when(F.col("p.rules").isNotNull(), F.size("p.rules")).cast("long")
    return p.select("doc_id", "p.action", indices.alias("indices"), note.alias("note_2"), n_rules.alias("n_rules"), "p.error")


#: Patterns of sensitive markers.
MARKERS = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "e-mail address"), (r"\b[0-9]{6,}\b", "long number"), (r"(?i)\blicensed\b", "license")]


@query(
    "WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) "
    + " UNION ALL ".join(f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, '{r}' AS reason FROM l WHERE regexp_matches(line, '{p}')" for p, r in MARKERS)
)
def marker_scan(spark, sf_dir):
    found = markers.scan(table(spark, sf_dir, "documents"), MARKERS)
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "reason")


_DENIED = """SELECT CASE c_custkey % 2 WHEN 0 THEN '(?i)xxxx' ELSE '[0-9]+ ?12-' END || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || CASE c_custkey % 3 WHEN 0 THEN '$' ELSE '' END AS pattern,
  c_mktsegment || ' ' || CAST(c_custkey % 10000 AS STRING) AS reason, lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS literal FROM customer"""


@query(
    f"""WITH {STMT}, k AS ({_DENIED}), l AS (SELECT o_orderkey, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM stmt),
 x AS (SELECT *, unnest({_runs_sql('line', 4)}) AS run FROM l)
 SELECT o_orderkey, CAST(line_no AS INTEGER) AS line_no, reason FROM x JOIN k ON run = literal WHERE regexp_matches(line, pattern)"""
)
def marker_scan_by_table(spark, sf_dir):
    """Lines that match the pattern of a customer, from a table."""
    docs = statements(spark, sf_dir)
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return markers.scan_by(docs, spark.sql(_DENIED), id_col="o_orderkey").select("o_orderkey", "line_no", "reason")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_counts(spark, sf_dir):
    return markers.status_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")))


@query("""SELECT o_orderkey AS "index", o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS approved FROM orders""")
def approved_set(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("index"))
    return P.approved(files, files.where("index % 3 = 0"), files.where("index % 5 = 0"))

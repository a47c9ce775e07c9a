"""The test tables seen as fact tables, for Spark and, in the same shape, as SQL for the oracle.

documents are files; parts are symbols and what their brands import; foreign keys are dependency edges; conversations
are requests; events are observations and outcomes; labels are certificates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import import_fact_id, symbol_fact_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- documents as files ----------------------------------------------------------------------------------------------


def files(spark: SparkSession, d: str) -> DataFrame:
    """snapshot_id, relative_path, extension, language, size_bytes, content_hash and text."""
    t = F.coalesce("text", F.lit(""))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, d, "documents").select(F.lit("docs").alias("snapshot_id"), path.alias("relative_path"), F.lit("md").alias("extension"), F.col("lang").alias("language"), F.octet_length(t).cast("long").alias("size_bytes"), F.md5(t.cast("binary")).alias("content_hash"), t.alias("text"))


FILES = """files AS (
  SELECT 'docs' AS snapshot_id, concat(source, '/', lang, '/doc_', doc_id, '.md') AS relative_path, 'md' AS extension, lang AS language,
    octet_length(encode(coalesce(text, ''))) AS size_bytes, md5(coalesce(text, '')) AS content_hash, coalesce(text, '') AS text FROM documents
)"""


def two_snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A reference without German files and a target without French ones, in which Spanish ones have changed."""
    f = files(spark, d)
    changed = F.when(F.col("language") == "es", F.md5(F.concat("text", F.lit("x")).cast("binary"))).otherwise(F.col("content_hash"))
    return f.where("language <> 'de'"), f.where("language <> 'fr'").withColumn("content_hash", changed)


TWO = """ref AS (SELECT * FROM files WHERE language <> 'de'),
tgt AS (SELECT * REPLACE (CASE WHEN language = 'es' THEN md5(text || 'x') ELSE content_hash END AS content_hash) FROM files WHERE language <> 'fr')"""


# --- parts as symbols, and what their brands import -------------------------------------------------------------------

_KIND = "CASE WHEN p_type IN ('MEDIUM', 'ECONOMY', 'PROMO') THEN 'function' WHEN p_type = 'STANDARD' THEN 'struct' WHEN p_type = 'SMALL' THEN 'enum' ELSE 'constant' END"


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Parts: their name, by brand (the path) and size (the line)."""
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), F.expr(_KIND).alias("kind"), F.col("p_brand").alias("relative_path"), F.lit("part").alias("language"), F.col("p_size").cast("long").alias("line_number")).distinct()
    return p.select(F.lit("parts").alias("snapshot_id"), symbol_fact_id("language", "relative_path", "line_number", "kind", "name").alias("fact_id"), "name", "kind", "relative_path", "language", "line_number", F.lit("lexical_confirmed").alias("evidence_class"))


def _san(x: str) -> str:
    return f"regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z]', '_', 'g')"


SYMBOLS = f"""symbols AS (
  SELECT DISTINCT 'sym_part_' || {_san("p_brand")} || '_' || p_size || '_' || {_KIND} || '_' || {_san("p_name")} AS fact_id,
    p_name AS name, {_KIND} AS kind, p_brand AS relative_path, 'part' AS language, CAST(p_size AS BIGINT) AS line_number, 'lexical_confirmed' AS evidence_class FROM part
)"""


def part_imports(spark: SparkSession, d: str) -> DataFrame:
    """What a brand imports: a part of the brand whose number its size gives; sizes over 40 lead nowhere."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("importer_path"), F.concat("p_type", F.lit("::"), "p_name").alias("import_spec"), F.col("p_size").cast("long").alias("line_number")).distinct()
    to = F.when(F.col("line_number") <= 40, F.concat(F.lit("Brand#"), (F.col("line_number") % 25 + 1).cast("string")))
    return p.select(F.lit("parts").alias("snapshot_id"), import_fact_id(F.lit("part"), "importer_path", "line_number", F.lit("use"), "import_spec").alias("fact_id"), "importer_path", "import_spec", "line_number", F.lit("part").alias("language"), F.lit("use").alias("kind"), to.alias("resolved_path"), F.lit("lexical_confirmed").alias("evidence_class"))


PART_IMPORTS = f"""imports AS (
  SELECT DISTINCT 'imp_part_' || {_san("p_brand")} || '_' || p_size || '_use_' || {_san("p_type || '::' || p_name")} AS fact_id, p_brand AS importer_path,
    p_type || '::' || p_name AS import_spec, CAST(p_size AS BIGINT) AS line_number, 'part' AS language,
    CASE WHEN p_size <= 40 THEN 'Brand#' || (p_size % 25 + 1) END AS resolved_path FROM part
)"""


def changed_symbols(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A reference without one brand's symbols and a target without another's, in which rings are hoops, three lines on."""
    s = symbols(spark, d)
    name = F.regexp_replace("name", "ring", "hoop")
    moved = F.when(name != F.col("name"), F.col("line_number") + 3).otherwise(F.col("line_number"))
    t = s.where("relative_path <> 'Brand#4'").withColumn("line_number", moved).withColumn("name", name)
    t = t.withColumn("fact_id", symbol_fact_id("language", "relative_path", "line_number", "kind", "name"))
    return s.where("relative_path <> 'Brand#3'"), t


SYMBOLS_TWO = f"""sref AS (SELECT * FROM symbols WHERE relative_path <> 'Brand#3'),
moved AS (
  SELECT * REPLACE (replace(name, 'ring', 'hoop') AS name, CASE WHEN contains(name, 'ring') THEN line_number + 3 ELSE line_number END AS line_number)
  FROM symbols WHERE relative_path <> 'Brand#4'
), stgt AS (
  SELECT * REPLACE ('sym_part_' || {_san("relative_path")} || '_' || line_number || '_' || kind || '_' || {_san("name")} AS fact_id) FROM moved
)"""


# --- foreign keys as edges -------------------------------------------------------------------------------------------

_KEYS = (
    ("nation", "n_nationkey", "region", "n_regionkey"),
    ("customer", "c_custkey", "nation", "c_nationkey"),
    ("supplier", "s_suppkey", "nation", "s_nationkey"),
    ("orders", "o_orderkey", "customer", "o_custkey"),
)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """nation to region, customer and supplier to nation, orders to customer: as imports, a line each."""
    out = None
    for name, key, to, other in _KEYS:
        rows = table(spark, d, name).select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("importer_path"), F.lit(to).alias("import_spec"), F.concat(F.lit(f"{to}:"), F.col(other).cast("string")).alias("resolved_path"))
        out = rows if out is None else out.union(rows)
    out = out.select(F.lit("keys").alias("snapshot_id"), "importer_path", "import_spec", F.lit(1).cast("long").alias("line_number"), F.lit("fk").alias("language"), F.lit("use").alias("kind"), "resolved_path", F.lit("lexical_confirmed").alias("evidence_class"))
    return out.withColumn("fact_id", import_fact_id("language", "importer_path", "line_number", "kind", "import_spec"))


EDGES = "edges AS (\n  " + "\n  UNION ALL ".join(f"SELECT '{n}:' || {k} AS a, '{t}:' || {o} AS b, '{t}' AS spec FROM {n}" for n, k, t, o in _KEYS) + "\n)"


def nation_seeds(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("request_id"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("relative_path"))


# --- conversations as requests ---------------------------------------------------------------------------------------

TASKS = ("query", "safe_edit", "explain_flow", "blast_radius", "semantic_diff", "repo_onboarding")
DEPTHS = ("compact", "standard", "deep")
BUDGETS = (100, 600, 2000)


def requests(spark: SparkSession, d: str) -> DataFrame:
    """A request for each user's turn: its text is the goal, the role and language of the next turn do not matter. Task, depth
    and budgets follow the conversation's number."""
    c = table(spark, d, "conversations").where("role = 'user'")
    pick = lambda values, by: F.get(F.array(*[F.lit(x) for x in values]), (F.col("conv_id") % by).cast("int"))
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.coalesce("text", F.lit("")).alias("goal"), F.coalesce(F.reverse("text"), F.lit("")).alias("question"), pick(TASKS, 6).alias("task_type"), pick(DEPTHS, 3).alias("depth"),
        F.when(F.col("conv_id") % 11 == 0, F.lit("background_worker")).otherwise("human").alias("consumer_type"), F.when(F.col("conv_id") % 4 < 3, pick(BUDGETS, 3)).cast("long").alias("latency_budget"),
        (F.col("conv_id") * 37 % 9000 + 500).cast("long").alias("token_budget"),
    )


REQUESTS = """requests AS (
  SELECT conv_id * 1000 + turn AS request_id, coalesce(text, '') AS goal, coalesce(reverse(text), '') AS question,
    (['query', 'safe_edit', 'explain_flow', 'blast_radius', 'semantic_diff', 'repo_onboarding'])[1 + conv_id % 6] AS task_type,
    (['compact', 'standard', 'deep'])[1 + conv_id % 3] AS depth, CASE WHEN conv_id % 11 = 0 THEN 'background_worker' ELSE 'human' END AS consumer_type,
    CASE WHEN conv_id % 4 < 3 THEN ([100, 600, 2000])[1 + conv_id % 3] END AS latency_budget, conv_id * 37 % 9000 + 500 AS token_budget
  FROM conversations WHERE role = 'user'
)"""

#: Words of the corpus in the place of the rule tables' own, which it does not have.
WORDS = {"bug": ("stion", "ück"), "feature": ("ation ", "para "), "why": ("thing", "mente"), "architecture": ("the ", "der ", "les ")}


def targets(spark: SparkSession) -> DataFrame:
    """Verification targets over the documents' folders."""
    rows = [
        ("all", "", ".", ["cargo", "xtask", "check"], "quality", "recommended"), ("one", "src1", "src1", ["cargo", "test"], "test", "required"), ("two", "src2/en", "src2/en", ["pytest", "-q"], "test", "required"),
        ("three", "src3", "src3", ["pnpm", "typecheck"], "typecheck", "required"), ("four", "src4/fr", "src4", ["python", "-m", "unittest"], "test", "recommended"),
    ]
    return spark.createDataFrame([("docs", *r) for r in rows], "snapshot_id string, label string, scope_root string, working_directory string, command array<string>, kind string, priority string")


TARGETS = """targets AS (SELECT * FROM (VALUES
  ('', 'cargo xtask check', 'recommended'), ('src1', 'cargo test (in src1)', 'required'), ('src2/en', 'pytest -q (in src2/en)', 'required'),
  ('src3', 'pnpm typecheck (in src3)', 'required'), ('src4/fr', 'python -m unittest (in src4)', 'recommended')) v(scope_root, chk, priority))"""


# --- events as observations ------------------------------------------------------------------------------------------


def observations(spark: SparkSession, d: str) -> DataFrame:
    """A run for each event: scenario by type, mutation by user, slots and cost by value and props."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    m = F.get(F.array(*[F.lit(x) for x in ("canonical", "terse", "typo", "symbolic_noise")]), (F.col("user_id") % 4).cast("int"))
    sets = F.array_compact(F.array(*[F.when(k % n == 0, F.lit(f"e{n}")) for n in (2, 3, 5, 7)]))
    slots = F.create_map(F.lit("anchor"), k % 2 == 0, F.lit("structural"), k % 3 == 0, F.lit("flow"), k % 5 == 0)
    return e.select(
        F.col("event_id").alias("run"), F.col("event_type").alias("scenario"), m.alias("mutation"), F.lit("a").alias("expected"), F.when(k < 90, "a").otherwise("b").alias("observed"), F.floor(F.col("value") * 1000).cast("long").alias("elapsed_micros"),
        (k >= 40).alias("sufficient"), F.lit(3).cast("long").alias("required"), F.size(F.filter(F.map_values(slots), lambda x: x)).cast("long").alias("satisfied"), (k % 2 == 0).cast("long").alias("baseline_hits"),
        slots.alias("slots"), sets.alias("evidence_ids"), F.col("value").alias("cost_ms"), (k % 4).alias("gained"), F.col("user_id"), F.col("ts").alias("at"), F.col("value"),
    )


OBSERVATIONS = """obs AS (
  SELECT event_id AS run, event_type AS scenario, (['canonical', 'terse', 'typo', 'symbolic_noise'])[1 + user_id % 4] AS mutation, k, value, user_id, ts,
    CASE WHEN k < 90 THEN 'a' ELSE 'b' END AS observed, CAST(floor(value * 1000) AS BIGINT) AS elapsed_micros, k >= 40 AS sufficient,
    list_filter(['anchor', 'structural', 'flow'], lambda x: (x = 'anchor' AND k % 2 = 0) OR (x = 'structural' AND k % 3 = 0) OR (x = 'flow' AND k % 5 = 0)) AS good,
    list_filter(['e2', 'e3', 'e5', 'e7'], lambda x: (x = 'e2' AND k % 2 = 0) OR (x = 'e3' AND k % 3 = 0) OR (x = 'e5' AND k % 5 = 0) OR (x = 'e7' AND k % 7 = 0)) AS ev
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""


def certificates(spark: SparkSession, d: str) -> DataFrame:
    """labels: good documents are proved, toxic ones refuted, others inconclusive; runs by source."""
    labels = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    status = F.when(F.col("toxic") == 1, "refuted").when(F.col("quality") == 1, "proved").otherwise("inconclusive")
    return labels.select(F.col("source").alias("run"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("obligation_id"), status.alias("status"), F.when(F.col("toxic") == 1, F.concat(F.lit("w"), F.col("doc_id").cast("string"))).alias("witness"), F.lit("rules").alias("solver"), F.lit(None).cast("string").alias("encoding_hash"))


CERTIFICATES = """certs AS (
  SELECT source AS run, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS obligation_id, CASE WHEN toxic = 1 THEN 'refuted' WHEN quality = 1 THEN 'proved' ELSE 'inconclusive' END AS status,
    CASE WHEN toxic = 1 THEN 'w' || doc_id END AS witness FROM labels JOIN documents USING (doc_id)
)"""
